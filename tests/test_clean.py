import datetime as dt
import random

import numpy as np
import pytest

from assayframe.functions.similarity import ratio_function, similar_function
from assayframe.operators import clean, fuzzy
from assayframe.operators.fuzzy import label_map
from assayframe.plans.facts import Facts
from conftest import rows


def greedy(labels, threshold):
    ratio, chosen, out = ratio_function(), [], {}
    for label in sorted(labels, key=lambda s: (len(s), s)):
        match = next((c for c in chosen if ratio(c, label) >= threshold), None)
        if match is None:
            chosen.append(label)
        else:
            out[label] = match
    return out


def plain_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 100.0 if not a and not b else 200.0 * table[-1][-1] / (len(a) + len(b))


def test_ratio_against_the_textbook_programme():
    rnd, ratio = random.Random(2), ratio_function()
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        assert ratio(a, b) == plain_ratio(a, b)


def noisy_labels(count, seed=4):
    rnd, words, out = random.Random(seed), ["north", "south", "premium", "standard", "entertainment", "ab", "customer 17"], set()
    while len(out) < count:
        w = list(rnd.choice(words))
        for _ in range(rnd.randint(0, 3)):
            if rnd.random() < 0.5:
                w.insert(rnd.randrange(len(w) + 1), rnd.choice("abcé "))
            elif w:
                w.pop(rnd.randrange(len(w)))
        out.add("".join(w))
    return out


@pytest.mark.parametrize("threshold,block", [(60, 1000), (75, 90), (88, 1000), (88, 70), (100, 1000)])
def test_label_map_equals_sequential_greedy(spark, threshold, block):
    labels = noisy_labels(180)
    df = spark.createDataFrame([("c", label) for label in labels], "column string, label string")
    assert {r["label"]: r["canonical"] for r in label_map(df, threshold, block).collect()} == greedy(labels, threshold)


def test_unlike_labels_take_few_rounds_and_a_crowd_stays_in_small_blocks(spark, monkeypatch):
    sizes, settle = [], fuzzy._settle_block
    monkeypatch.setattr(fuzzy, "_settle_block", lambda head, t: sizes.append(head.count()) or settle(head, t))
    rnd = random.Random(3)
    unlike = {"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(300)}
    df = spark.createDataFrame([("c", label) for label in unlike], "column string, label string")
    assert {r["label"]: r["canonical"] for r in label_map(df, 88, 10).collect()} == greedy(unlike, 88)
    assert len(sizes) <= 5
    monkeypatch.setattr(fuzzy, "PAIRS", 300)
    crowd = {f"one very long label with the number {i:03}" for i in range(150)}
    df = spark.createDataFrame([("c", label) for label in crowd], "column string, label string")
    assert {r["label"]: r["canonical"] for r in label_map(df, 95, 10).collect()} == greedy(crowd, 95)


@pytest.mark.parametrize("longest,alphabet", [(12, "ab"), (30, "abcé "), (150, "abcdefgh日本\0")])
def test_many_labels_compared_at_once_equal_the_plain_ratio(longest, alphabet):
    rnd, ratio = random.Random(longest), ratio_function()
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, longest))) for _ in range(5)]
    labels = [list(rnd.choice(base)) for _ in range(60)]
    for w in labels:
        for _ in range(rnd.randint(0, 6)):
            w.insert(rnd.randrange(len(w) + 1), rnd.choice(alphabet)) if rnd.random() < 0.5 or not w else w.pop(rnd.randrange(len(w)))
    labels = ["".join(w) for w in labels] + [""]
    for threshold in (50, 75, 88, 100):
        want = [[bool(a and b) and ratio(b, a) >= threshold for b in labels[::2]] for a in labels]
        for limits in ((), (1, 1), (300, 400)):
            assert similar_function(*limits)(labels, labels[::2], threshold).tolist() == want


@pytest.mark.parametrize("pairs", [0, 4_000_000])
def test_representatives_from_bits_equal_one_by_one(monkeypatch, pairs):
    monkeypatch.setattr(fuzzy, "PAIRS", pairs)
    rnd = np.random.default_rng(6)
    for n, share in ((1, 0.5), (40, 0.02), (61, 0.2), (64, 0.9)):
        alike = np.tril(rnd.random((n, n)) < share, -1)
        want = np.zeros(n, bool)
        for i in range(n):
            want[i] = not (alike[i] & want).any()
        assert (fuzzy.chosen_function()(np.packbits(alike, axis=1)) == want).all()


@pytest.mark.parametrize("direct,held", [(0, 0), (0, 1 << 14), (50, 20)])
def test_blocks_by_keys_equal_sequential_greedy(spark, monkeypatch, direct, held):
    monkeypatch.setattr(fuzzy, "DIRECT", direct)
    monkeypatch.setattr(fuzzy, "BROADCAST_LABELS", held)
    labels = noisy_labels(180)
    df = spark.createDataFrame([(c, label) for label in labels for c in "cd"], "column string, label string")
    found = label_map(df, 75, 40).collect()
    assert all({r["label"]: r["canonical"] for r in found if r["column"] == c} == greedy(labels, 75) for c in "cd")


def test_numbered_names_are_compared_without_keys(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "_probe_keys", None)  # their keys are those of nearly all names
    names = {f"customer#{i:09}" for i in range(0, 30_000, 5)}
    df = spark.createDataFrame([("c", name) for name in names], "column string, label string")
    assert {r["label"]: r["canonical"] for r in label_map(df, 88).collect()} == greedy(names, 88)


def test_standardise_keeps_nulls_and_rows(spark):
    df = spark.createDataFrame([(" Premium",), ("premum",), ("PREMIUM ",), (None,), ("Other",)], "s string")
    assert sorted(rows(clean.standardise_labels(df, ["s"])), key=repr) == sorted([("premum",)] * 3 + [(None,), ("other",)], key=repr)


@pytest.mark.parametrize("method,filled", [("mean", 4.0), ("median", 2.0), ("mode", 1.0), ("constant", 9.0)])
def test_impute_numbers(spark, method, filled):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0), (4, 3.0), (5, 13.0), (6, None)], "i int, x double")
    got = {r["i"]: r["x"] for r in clean.impute(df, "x", method, constant="9").collect()}
    assert got[6] == filled and got[5] == 13.0


def test_impute_text_column_keeps_other_cells(spark):
    df = spark.createDataFrame([("10",), ("20",), ("x",), (None,)], "v string")
    assert sorted(r[0] for r in clean.impute(df, "v", "mean").collect()) == ["10", "15", "20", "x"]


def test_impute_without_any_number_does_nothing(spark):
    df = spark.createDataFrame([("a",), (None,)], "v string")
    assert clean.impute(df, "v", "mean").where("v IS NULL").count() == 1


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        clean.impute(spark.range(1), "id", "magic")


def test_correct_types(spark):
    data = [("$1,000", "2024-01-02", "yes", "a")] * 19 + [("x", "2024-01-03", "no", "b")]
    out = clean.correct_types(spark.createDataFrame(data, "n string, d string, b string, c string"))
    assert dict(out.dtypes) == {"n": "double", "d": "timestamp_ntz", "b": "boolean", "c": "string"}
    assert out.where("n IS NULL").count() == 1 and out.where("n = 1000").count() == 19


def test_outlier_actions(spark):
    df = spark.createDataFrame([(i, float(i), 1.0) for i in range(20)] + [(20, 1000.0, 1.0), (21, None, 1.0)], "i int, x double, y double")
    facts = Facts(df, order_by="i")
    flagged = clean.flag_outliers(facts)
    assert flagged.columns == ["i", "x", "y", "x_is_outlier"] and [r["i"] for r in flagged.where("x_is_outlier").collect()] == [20]
    capped = {r["i"]: r["x"] for r in clean.cap_outliers(facts).collect()}
    assert capped[20] == facts.fences()["x"][1] and capped[5] == 5.0 and capped[21] is None
    assert sorted(r["i"] for r in clean.remove_outliers(facts).collect()) == [*range(20), 21]


def mixed(spark, rows_in=300):
    """Clean columns with the kinds of dirt the cleaning run must handle."""
    return spark.range(rows_in).selectExpr(
        "id", "concat('TX-', lpad(id, 5, '0')) AS txn_id",
        "if(id BETWEEN 46 AND 60, NULL, timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id AS INT))) AS date",
        "if(id BETWEEN 31 AND 45, NULL, 100 + CAST(id % 90 AS DOUBLE)) AS amount",
        "element_at(array('NYC', 'LA', 'CHI', 'nyc', 'HOU'), CAST(id % 5 AS INT) + 1) AS city",
        "if(id BETWEEN 21 AND 30, 'bad-email', concat('user', id % 100, '@example.com')) AS email",
        "if(id <= 20, 'invalid', CAST(18 + id % 50 AS STRING)) AS age",
    )


def test_run_logs_what_it_did(spark):
    df = mixed(spark)
    options = clean.CleaningOptions(
        imputation={"amount": "median", "date": "drop", "city": "magic", "nosuch": "mean"}, drop_duplicates=True,
        standardise=True, outlier_action="flag",
    )
    run = clean.CleaningRun(df.unionByName(df.limit(7).withColumn("id", df["id"] + 1000)), options=options, order_by="id")
    log = {(r["operation"], r["columns"]): r for r in run.log(dt.datetime(2024, 1, 1)).collect()}
    assert log["start", ""]["detail"] == "Began cleaning on 307 rows x 6 columns"
    assert log["duplicate-removal", "all"]["rows_affected"] == 7
    assert log["missing-impute", "amount"]["rows_affected"] == 15
    assert log["missing-drop", "date"]["rows_affected"] == 15
    assert log["missing-impute", "city"]["detail"].startswith("Could not impute using 'magic'")
    assert log["dtype-correction", "age"]["rows_affected"] == 21
    assert log["categorical-standardisation", "city"]["rows_affected"] == 228
    assert log["end", ""]["detail"] == "Cleaning complete: 285 rows x 6 columns"
    assert run.cleaned.count() == 285 and dict(run.cleaned.dtypes)["age"] == "double"
    assert run.cleaned.where("date IS NULL OR amount IS NULL").count() == 0


@pytest.mark.parametrize("action", ["cap", "remove"])
def test_run_outlier_actions(spark, action):
    df = spark.createDataFrame([(i, float(i % 20)) for i in range(60)] + [(60, 5000.0)], "i int, x double")
    run = clean.CleaningRun(df, options=clean.CleaningOptions(outlier_action=action), order_by="i")
    affected = {r["operation"]: r["rows_affected"] for r in run.log().collect()}
    assert affected[f"outlier-{action}"] == 1
    assert run.cleaned.count() == (61 if action == "cap" else 60) and run.cleaned.agg({"x": "max"}).first()[0] < 100


def test_run_forward_fill_after_a_drop(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 50.0), (3, "a", None), (4, "b", None), (5, "b", 5.0)], "i int, s string, x double")
    run = clean.CleaningRun(df, options=clean.CleaningOptions(imputation={"s": "drop", "x": "ffill"}, correct_types=False), order_by="i")
    assert sorted(rows(run.cleaned.select("i", "x"))) == [(1, 1.0), (3, 1.0), (4, 1.0), (5, 5.0)]
    assert [r["rows_affected"] for r in run.log().where("operation LIKE 'missing%'").collect()] == [1, 2]
