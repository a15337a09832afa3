import random
import re
from collections import Counter
from math import comb

import pytest

from docweave.llm.rules import MEASURES, RULES, binomial_tail, certified, chosen, fit_cutoffs, keep_by_rules, measure, quality_rules, with_measures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    inside = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def corpus(seed, n=200):
    rng = random.Random(seed)
    words = ["alpha", "é b", "Γ", "#x*", "<b>", "a\x1cb", "dd"]
    texts = [None, "", " \n\t\x0b", "\n\n", "one"]
    while len(texts) < n:
        k = rng.choice([5, 30, 200])
        texts.append("".join(rng.choice(words[: rng.randrange(1, 8)]) + rng.choice([" ", " ", "\n", "\r\n", "\t"]) for _ in range(rng.randrange(k))))
    return texts


def test_measures_match_brute_force():
    for t in corpus(1):
        assert measure(None if t is None else t.encode())[:5] == slow(t)


@pytest.mark.parametrize("n, x, p", [(10, 0, 0.1), (50, 3, 0.02), (200, 200, 0.5), (1000, 12, 0.01), (500, 0, 0.007), (900, 300, 0.3), (2000, 3, 0.01), (60, 59, 0.9)])
def test_tail_is_exact(n, x, p):
    assert binomial_tail(n, x, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1)), rel=1e-9)


def test_false_rejection_is_controlled():
    """Where every cutoff rejects just more than alpha, at most about the level of the trials certify any."""
    rng = random.Random(2)
    wrong = sum(certified(2000, [sum(rng.random() < 0.0205 for _ in range(2000))], 0.02, 0.05) > 0 for _ in range(400))
    assert wrong <= 0.05 * 400 + 3 * (400 * 0.05 * 0.95) ** 0.5


def labelled(spark, n=3000, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.15
        text = " ".join(rng.choice("lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy".split()) + ("$$$" if bad else "") for _ in range(40))
        rows.append((i, text, None if i % 50 == 0 else "xx" if i % 300 == 1 else "en", 7))
        labels.append((i, int(not bad)))
    rows += [(None, rows[0][1], "en", 7), (n, None, "en", 7), (n + 1, "", "en", 7), (1, rows[1][1], "en", 7)]
    labels += [(2, None), (3, labels[3][1])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, N_WORDS int"), spark.createDataFrame(labels, "doc_id long, quality int"), rows, labels


def test_query_matches_brute_force_and_rejects_bad(spark):
    df, labels, rows, marks = labelled(spark)
    out = quality_rules(df, labels).toPandas()
    assert len(out) == len(rows)
    want = sorted((-1 if r[0] is None else r[0], *slow(r[1])) for r in rows)
    got = out.assign(doc_id=out.doc_id.fillna(-1).astype(int))[["doc_id", *MEASURES[:5]]].values.tolist()
    assert sorted(map(tuple, got)) == want
    base = (out.n_words < 20) | (100 * out.n_repeat_words > 30 * out.n_words)
    assert (out.base_failed == base).all() and not (out.kept & base).any()
    truth = dict(marks[:-2])
    own = out[~out.base_failed & (out.stratum == "en") & out.doc_id.isin(truth)]
    bad = own.doc_id.map(truth) == 0
    assert bad.sum() > 200 and not own.kept[bad].any() and own.kept[~bad].all()
    assert out.kept[(out.stratum != "en") & ~out.base_failed].all()  # too few labels to certify a cutoff
    kept = keep_by_rules(df, labels)
    assert kept.columns == df.columns and kept.count() == out.kept.sum()


def test_cutoffs_follow_the_counts(spark):
    """Bad documents have some signs; good ones now and then a few. The cutoff lies between."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(4000):
        bad = rng.random() < 0.2
        signs = 20 if bad else 3 if rng.random() < 0.003 else 0
        rows.append((i, " ".join(rng.choice("lorem ipsum dolor sit amet elitr sed diam".split()) for _ in range(40)) + " " + "#" * signs, "en"))
        labels.append((i, int(not bad)))
    df, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    found = with_measures(df, "text", MEASURES, ["doc_id", "lang"])
    cutoffs = fit_cutoffs(found, marks, "lang", "doc_id")
    assert set(cutoffs) == {"en"} and 3 / 41 < cutoffs["en"]["symbols"] < 20 / 41
    out = quality_rules(df, marks).toPandas().merge(marks.toPandas(), on="doc_id")
    assert (out.kept == (out.quality == 1))[~out.base_failed].all()


def test_without_labels_or_rows(spark):
    df, labels, _, _ = labelled(spark, 50)
    out = quality_rules(df, labels.limit(0)).toPandas()
    assert (out.kept == ~out.base_failed).all()
    assert quality_rules(df.limit(0), labels).count() == 0 and keep_by_rules(df.limit(0), labels).count() == 0


def test_small_strata_share_cutoffs(spark):
    """Three languages of some 400 good labels each: too few for one, enough together. One without labels is left alone."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        rows.append((i, " ".join(rng.choice("lorem ipsum dolor sit amet elitr sed diam".split()) for _ in range(40)) + " " + "#" * 20 * bad, ("de", "fr", "es")[i % 3]))
        labels.append((i, int(not bad)))
    rows += [(-1 - i, rows[0][1], "xx") for i in range(5)]
    df, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    cutoffs = fit_cutoffs(with_measures(df, "text", MEASURES, ["doc_id", "lang"]), marks, "lang", "doc_id")
    assert set(cutoffs) == {"de", "fr", "es"} and cutoffs["de"] == cutoffs["fr"] == cutoffs["es"] and "symbols" in cutoffs["de"]
    out = quality_rules(df, marks).toPandas()
    assert (out.kept[out.doc_id >= 0] == (out.doc_id[out.doc_id >= 0] % 5 != 0))[~out.base_failed].all()
    assert out.kept[(out.doc_id < 0) & ~out.base_failed].all()
    assert set(fit_cutoffs(with_measures(df.limit(600), "text", MEASURES, ["doc_id", "lang"]), marks, "lang", "doc_id")) == set()


def test_copies_are_no_trials(spark):
    """Repeating rows, or texts under new ids, leaves the cutoffs as they were; 500 texts certify nothing however often they come."""
    rng = random.Random(8)

    def rows(n, bad_share):
        return [(i, " ".join(rng.choice("lorem ipsum dolor sit amet elitr sed diam".split()) for _ in range(40)) + " #" * (15 * (rng.random() < bad_share)), "en") for i in range(n)]

    schema = "doc_id long, text string, lang string"
    for n in (500, 2500):
        own = rows(n, 0.2)
        marks = spark.createDataFrame([(i, int("#" not in t)) for i, t, _ in own], "doc_id long, quality int")
        many = [(i + 10**6 * k, t, s) for k in range(6) for i, t, s in own]
        many_marks = spark.createDataFrame([(i, int("#" not in t)) for i, t, _ in many] * 2, "doc_id long, quality int")
        plain = quality_rules(spark.createDataFrame(own, schema), marks)
        again = quality_rules(spark.createDataFrame(own * 5, schema), marks)
        copied = quality_rules(spark.createDataFrame(many, schema), many_marks)
        truth = {r["doc_id"]: r["kept"] for r in plain.collect()}
        assert all(truth.values()) == (n == 500)
        assert all(truth[r["doc_id"]] == r["kept"] for r in again.collect())
        assert all(truth[r["doc_id"] % 10**6] == r["kept"] for r in copied.collect())


def test_all_rules_together_reject_at_most_alpha():
    """Good texts that go over each cutoff at a rate of its own, independently by rule: what the chosen cutoffs reject together is over alpha in at most about delta of the trials."""
    rng = random.Random(10)
    alpha, delta, n, wrong = 0.049, 0.05, 3000, 0
    for _ in range(60):
        rates, counts = {}, {}
        for k, (_, cutoffs) in enumerate(RULES.values()):
            steps = sorted(rng.random() * 0.02 for _ in cutoffs)  # share over the c-th cutoff, from lenient to strict
            rates[k] = steps
            good: dict[int, int] = {}
            for _ in range(n):
                u = rng.random()
                over = sum(u < s for s in steps)
                good[over] = good.get(over, 0) + 1
            counts[k] = (good, {len(cutoffs): 1000})
        found = chosen(counts, alpha / len(RULES), delta / len(RULES), 1.0)
        stay = 1.0
        for k, (name, (_, cutoffs)) in enumerate(RULES.items()):
            if name in found:
                stay *= 1 - rates[k][cutoffs.index(found[name])]
        wrong += 1 - stay > alpha
    assert wrong <= 0.05 * 60 + 4


def test_long_texts_and_clashing_names(spark):
    text = "alpha beta gamma. " * 60_000 + "\n" + " ".join(f"w{i}" for i in range(50_000))
    names = [*MEASURES, "cutoffs", "stratum", "passed", "row", "text_hash", "cutoffs_", "stratum_of_cutoffs"]
    df = spark.createDataFrame([(1, text, None, *range(len(names))), (2, " ".join(f"w{i}" for i in range(300_000)), None, *range(len(names)))], "doc_id long, text string, lang string, " + ", ".join(f"`{n.upper()}` int" for n in names))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert sorted((r["doc_id"], r["n_words"], r["base_failed"]) for r in quality_rules(df, labels).collect()) == [(1, 230_000, True), (2, 300_000, False)]
    kept = keep_by_rules(df, labels)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [2]
