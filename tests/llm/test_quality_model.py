import math

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, frame, words

from pvtide.llm import quality_model as quality
from pvtide.llm.textkernels import utf8_pieces


def stats_of(text):
    (_, data, offsets), = utf8_pieces(pa.array([text]))
    return dict(zip(quality.STATISTICS, quality.statistics(data, offsets)[0][0], strict=True))


def test_statistics_of_small_texts():
    text = "The cat, the CAT and the cat!!\nx # y\nx # y"
    s = stats_of(text)
    assert s["n_words"] == 11 and s["symbol_ratio"] == 4 / len(text) and s["run_ratio"] == 1 / len(text)
    assert s["noisy_ratio"] == 3 / 13 and s["loose_ratio"] == 2 / 13
    assert s["capital_ratio"] == 4 / 25 and s["repeated_line_ratio"] == 1 / 3
    assert s["function_ratio"] == (4 + 2) / 11  # the, the, and, the; French y is a function word of Spanish
    assert stats_of("a a a b")["echo_ratio"] == 2 / 4
    assert stats_of("été à")["word_length"] == 2.0


@pytest.mark.parametrize("seed", [1, 2])
def test_em_recovers_accuracies_of_simulated_labellers(seed):
    rng = np.random.default_rng(seed)
    n, k = 60_000, len(quality.LABELLERS)
    good = rng.random(n) < 0.85
    right_good, right_bad = rng.uniform(0.9, 0.995, k), rng.uniform(0.55, 0.9, k)
    cast = rng.random((n, k)) < 0.9
    right = rng.random((n, k)) < np.where(good[:, None], right_good, right_bad)
    v = np.where(cast, np.where(right, good[:, None], ~good[:, None]).astype(int), quality.ABSTAIN)
    numbers, counts = np.unique(quality.pattern_numbers(v), return_counts=True)
    assert (quality.pattern_votes(quality.pattern_numbers(v)) == v).all()
    model = quality.fit_label_model(numbers, counts)
    assert abs(model["prior"] - 0.85) < 0.02
    assert np.abs(model["accuracy"] - np.stack([right_good, right_bad])).max() < 0.05
    label = dict(zip(numbers.tolist(), model["posterior"], strict=True))
    guess = np.array([label[p] for p in quality.pattern_numbers(v).tolist()]) > 0.5
    assert (guess == good).mean() > 0.98


def test_features_are_unit_words_and_one_per_statistic():
    (_, data, offsets), = utf8_pieces(pa.array(["a b a", ""]))
    (i, x), (j, y) = quality.hashed_features(*quality.statistics(data, offsets))
    assert (np.diff(i) > 0).all() and x.sum() == pytest.approx(3 / math.sqrt(5) + len(quality.STATISTICS))
    assert y.sum() == len(quality.STATISTICS) and max(i.max(), j.max()) < 1 << quality.HASH_BITS


def test_held_out_accuracy_against_labels(spark):
    """The label table is not used in training: it measures the scorer."""
    sf = "/root/testdata/sf0.1"
    got = quality.score_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "truth"), "doc_id").collect()
    good = [r.keep for r in both if r.truth == 1]
    bad = [r.keep for r in both if r.truth == 0]
    assert len(good) > 3000 and len(bad) > 400
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.15


def test_awkward_rows(spark):
    rows = AWKWARD + [(100 + i, words(60, i) + " the of and to in. " * 5) for i in range(30)]
    got = quality.score_documents(frame(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.quality <= 1 and len(r.votes) == len(quality.LABELLERS) for r in got)
    empty = {r.doc_id: r for r in got if r.doc_id in (3, 4, 5)}
    assert all(r.quality == 0 and not r.keep for r in empty.values()) and len(empty) == 3
    assert quality.score_documents(frame(spark, [])).count() == 0
