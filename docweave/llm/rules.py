"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

Each rule compares one measure of a text with a cutoff. Cutoffs are chosen per stratum (language; those with few labels are one) on labelled documents: the hypothesis "this
cutoff rejects more than alpha of the good documents" is tested exactly (binomial tail, the test that inverts the Clopper-Pearson
bound) from the most lenient cutoff on, and a chain of tests ends at the first cutoff that can't be certified. Testing in a
fixed order needs no correction within a chain; across chains (strata times rules) the level is divided by their number. So
with probability 1 - delta every cutoff used rejects at most its share of alpha, alpha over the number of rules, of the good documents of
its stratum, and so the rules together reject at most alpha of them. Trials are different texts of different ids: repeated rows and exact
copies prove nothing more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import discard, fresh, mapped, raw, stored

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: What a text is measured by: whole numbers, from which the rules take ratios.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_echo_words"]
#: Rule: its value as SQL over the measures, and the cutoffs from lenient to strict; a text fails with a greater value.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", [2, 1.5, 1, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.29, 0.27, 0.25, 0.22, 0.2, 0.17, 0.15, 0.12, 0.1]),
    "upper": ("n_upper / greatest(word_chars, 1)", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2]),
    "echo": ("n_echo_words / greatest(n_words, 1)", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1]),
    "long_words": ("word_chars / greatest(n_words, 1)", [60, 40, 30, 25, 20, 17, 15, 13, 12, 11, 10]),
    "short_words": ("- word_chars / greatest(n_words, 1)", [-1.2, -1.5, -1.8, -2, -2.2, -2.5, -2.8, -3]),
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of words that occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        key = np.zeros(n, dtype=np.uint64)
        for k in range(window):
            key = key * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    a, b = order[1:][same], order[:-1][same]
    steps = np.arange(window)
    if not (ids[a[:, None] + steps] == ids[b[:, None] + steps]).all():  # equal hashes of different windows
        seen: dict[bytes, int] = {}
        windows = [ids[i : i + window].tobytes() for i in range(n)]
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        starts = np.array([i for i, w in enumerate(windows) if seen[w] > 1], dtype=np.int64)
    else:
        starts = np.union1d(a, b)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The MEASURES of a text. Words are [^\\x20\\x09-\\x0D]+; a null text has none."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.split()
    data = np.frombuffer(text, np.uint8)
    starts = int((data & 0xC0 != 0x80).sum())  # code points
    spaces = int(((data == 32) | ((data >= 9) & (data <= 13))).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = int(((data >= 65) & (data <= 90)).sum())
    echo = sum(map(bytes.__eq__, words[1:], words))
    return (len(words), starts - spaces, sum(map(text.count, (bytes([s]) for s in SYMBOLS))), len(lines) - len(set(lines)), repeated_words(words), len(lines), upper, echo)


def with_measures(documents: DataFrame, text_col: str, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """documents (or its columns keep) and the measures of its texts under names."""
    keep = documents.columns if keep is None else keep
    at = documents.columns.index(text_col)
    places = [documents.columns.index(c) for c in keep]

    def add(batches):
        for b in batches:
            found = np.array([measure(t) for t in raw(b.column(at))], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in places), *map(pa.array, found.T.copy())], names=[*keep, *names])

    fields = [documents.schema.fields[i] for i in places] + [T.StructField(n, T.LongType()) for n in names]
    return mapped(documents, add, T.StructType(fields))


def binomial_tail(n: int, x: int, p: float) -> float:
    """P(Binomial(n, p) <= x): the incomplete beta function of 1 - p at (n - x, x + 1), whose cost does not grow with x."""
    if x >= n:
        return 1.0
    if x < 0:
        return 0.0
    a, b = n - x, x + 1
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log1p(-p) + b * math.log(p))
    if 1 - p < (a + 1) / (a + b + 2):
        return min(1.0, front * _beta_fraction(a, b, 1 - p) / a)
    return max(0.0, 1 - front * _beta_fraction(b, a, p) / b)


def _beta_fraction(a: float, b: float, x: float, rounds: int = 100_000) -> float:
    """The continued fraction of the incomplete beta function, from the front (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, rounds):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def certified(n: int, rejected: list[int], alpha: float, level: float) -> int:
    """How many cutoffs, from the lenient end, are certified to reject at most alpha of the good documents."""
    for k, x in enumerate(rejected):
        if binomial_tail(n, x, alpha) > level:
            return k
    return len(rejected)


def chosen(counts: dict[int, tuple[dict[int, int], dict[int, int]]], alpha: float, level: float, worth: float) -> dict[str, float]:
    """The cutoff of each rule of a stratum, if any. counts: by rule, how many good and bad texts are over how many of its cutoffs.

    Of the certified cutoffs only those count that reject bad documents at `worth` times the rate of good ones, or more; of these the most
    lenient one is used that rejects as many bad documents, within one in a hundred, as any.
    """
    out = {}
    for k, (name, (_, cutoffs)) in enumerate(RULES.items()):
        good, bad = counts.get(k, ({}, {}))
        # a value over the c-th cutoff is over all stricter ones too
        above = lambda h: [sum(n for over, n in h.items() if over >= len(cutoffs) - c) for c in range(len(cutoffs))]
        n_good, n_bad = sum(good.values()), sum(bad.values())
        lost, caught = above(good), above(bad)
        passed = certified(n_good, lost, alpha, level)
        telling = [c for c in range(passed) if caught[c] * n_good >= worth * (lost[c] + 1) * n_bad]
        if telling:
            most = max(caught[c] for c in telling)
            out[name] = cutoffs[next(c for c in telling if 100 * caught[c] >= 99 * most)]
    return out


def cutoff_table(measures: DataFrame, labels: DataFrame, stratum: str, id_col: str, label_col: str = "quality", alpha: float = 0.049, delta: float = 0.05, worth: float = 10.0, hash_col: str | None = None) -> DataFrame:
    """stratum, cutoffs (a map by rule), a row for each stratum with any, from labelled documents: measures has id_col, stratum and the MEASURES.

    An id counts once, and so does each text of a stratum and label, by hash_col if given: copies are no trials of their own. Strata with
    too few good texts to certify anything are one common stratum, with chains of its own, whose guarantee is for their good
    documents together; strata without a good text get no cutoffs. Each stratum's counts are judged where they are grouped; only how
    many strata there are reaches the driver. Null labels are ignored; repeated labels of one id count as one, the smallest.
    """
    spark = measures.sparkSession
    share = alpha / len(RULES)
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).alias("y"))
    known = measures.join(marks, F.col(id_col) == F.col("i")).where("NOT " + BASE_FAILED)
    levels = []
    for value, cutoffs in RULES.values():
        levels.append(F.expr(f"CAST(size(filter(array({', '.join(f'{float(c)}D' for c in cutoffs)}), c -> CAST({value} AS DOUBLE) > c)) AS INT)"))
    text = F.col(hash_col) if hash_col else F.col("i")
    one = known.groupBy("i").agg(F.min(F.struct(text.alias("t"), F.col(stratum).alias("s"), "y", F.array(*levels).alias("levels"))).alias("r")).select("r.*")
    texts = stored(one.groupBy("s", "y", "t").agg(F.min("levels").alias("levels")), "labelled-texts")
    sums = texts.where("y = 1").groupBy("s").agg(F.count("*").alias("good"))
    least = math.log(delta / len(RULES)) / math.log1p(-share)
    enough, few = stored(sums.where(F.col("good") >= least).select("s"), "strata"), stored(sums.where(F.col("good") < least).select("s"), "small-strata")
    pooled = texts.join(few, "s").groupBy(F.lit(None).cast("string").alias("s"), "y", "t").agg(F.min("levels").alias("levels"))
    pooled_counts = pooled.where("y = 1").count()
    chains = enough.count() + (pooled_counts >= least)
    out_schema = "stratum string, cutoffs map<string,double>"
    if not chains:
        discard(texts, enough, few)
        return spark.createDataFrame([], out_schema)
    every = texts.join(enough, "s", "left_semi").select("s", "y", "t", "levels")
    if pooled_counts >= least:
        every = every.unionByName(pooled)
    counts = every.select("s", "y", F.posexplode("levels").alias("rule", "over")).groupBy("s", "y", "rule", "over").agg(F.count("*").alias("n"))
    counts = counts.groupBy("s").agg(F.collect_list(F.struct("y", "rule", "over", "n")).alias("c"))  # a bounded number a stratum
    level = delta / (len(RULES) * chains)

    def judge(batches):
        for b in batches:
            found = []
            for own in b.column(1).to_pylist():
                table: dict[int, tuple[dict, dict]] = {}
                for c in own:
                    good, bad = table.setdefault(c["rule"], ({}, {}))
                    (good if c["y"] == 1 else bad)[c["over"]] = c["n"]
                found.append(list(chosen(table, share, level, worth).items()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.map_(pa.string(), pa.float64()))], names=["stratum", "cutoffs"])

    found = stored(mapped(counts, judge, out_schema).where("size(cutoffs) > 0"), "cutoffs")
    shared = found.where("stratum IS NULL").select("cutoffs")  # one row
    out = stored(found.where("stratum IS NOT NULL").unionByName(few.select(F.col("s").alias("stratum")).crossJoin(F.broadcast(shared))), "cutoffs")
    discard(texts, enough, few, found)
    return out


def fit_cutoffs(measures: DataFrame, labels: DataFrame, stratum: str, id_col: str, **more) -> dict[str, dict[str, float]]:
    """cutoff_table on the driver, for reports on few strata."""
    return {r["stratum"]: dict(r["cutoffs"]) for r in cutoff_table(measures, labels, stratum, id_col, **more).collect()}


BASE_FAILED = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"


def judged(rows: DataFrame, cutoffs: DataFrame, stratum: str, name: str) -> DataFrame:
    """rows with a column that is true if no rule of the row's stratum rejects it."""
    s, c = fresh(rows, "stratum_of_cutoffs", "cutoffs_")
    failed = F.lit(False)
    for rule, (value, _) in RULES.items():
        failed = failed | F.coalesce(F.expr(f"CAST({value} AS DOUBLE)") > F.col(c)[rule], F.lit(False))
    both = rows.join(cutoffs.select(F.col("stratum").alias(s), F.col("cutoffs").alias(c)), F.col(stratum) == F.col(s), "left")
    return both.withColumn(name, ~failed).drop(s, c)


def _measured(documents: DataFrame, id_col: str, text_col: str, stratum_col: str | None) -> DataFrame:
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    text = F.col(text_col).cast("string")
    docs = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"), stratum.alias("stratum"), F.xxhash64(text).alias("text_hash"))
    return with_measures(docs, "text", MEASURES, ["doc_id", "stratum", "text_hash"])


def _fitted(found: DataFrame, labels: DataFrame, id_col: str, alpha: float, delta: float) -> DataFrame:
    return cutoff_table(found, labels.select(F.col(id_col).alias("doc_id"), "quality"), "stratum", "doc_id", alpha=alpha, delta=delta, hash_col="text_hash")


def quality_rules(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", alpha: float = 0.049, delta: float = 0.05) -> DataFrame:
    """doc_id, stratum, the MEASURES, base_failed and kept, a row for each row of documents.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated 8-word windows. kept: not base_failed, and no certified rule
    rejects the row. Cutoffs come from all labelled documents (see cutoff_table): with probability 1 - delta the rules together
    reject at most alpha of the good documents of any stratum that pass the base rules.

    Defined cases: a null, empty or blank text has no words and fails the base rules. A null stratum is the stratum "". Null ids
    have no labels but are judged like any row. Repeated rows are returned each and fit like one. An empty table gives no rows; without
    labels nothing is certified and only the base rules act. Other columns are ignored.
    """
    found = stored(_measured(documents, id_col, text_col, stratum_col), "measures")
    base = F.expr(BASE_FAILED)
    out = judged(found, _fitted(found, labels, id_col, alpha, delta), "stratum", "passed")
    return out.select("doc_id", "stratum", *MEASURES, base.alias("base_failed"), (~base & F.col("passed")).alias("kept"))


def keep_by_rules(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", alpha: float = 0.049, delta: float = 0.05) -> DataFrame:
    """The rows of documents that quality_rules keeps, with all their columns.

    Texts are measured twice, once to fit and once to filter, so that they need not be shuffled. Defined cases are those of quality_rules:
    rows of null, empty and blank texts go, null ids and null strata are judged like any, repeated rows stay or go together, and columns
    may have any names.
    """
    found = stored(_measured(documents, id_col, text_col, stratum_col), "measures")
    cutoffs = _fitted(found, labels, id_col, alpha, delta)
    discard(found)
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    # the row travels as one struct, so that no column of it can clash with a measure
    rows = documents.select(F.struct(*documents.columns).alias("row"), stratum.alias("stratum"))
    at = documents.columns.index(text_col)

    def add(batches):
        for b in batches:
            found = np.array([measure(t) for t in raw(b.column(0).field(at))], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, found.T.copy())], names=[*b.schema.names, *MEASURES])

    rows = mapped(rows, add, T.StructType(rows.schema.fields + [T.StructField(n, T.LongType()) for n in MEASURES])).where("NOT " + BASE_FAILED)
    return judged(rows, cutoffs, "stratum", "passed").where("passed").select("row.*")


def op3_quality_rules(spark, sf_dir):
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
