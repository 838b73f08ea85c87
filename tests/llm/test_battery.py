"""The randomness battery against tokens drawn from its model of written text, and random ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import secrets_scan

# Letter frequencies of English in percent, a to z.
ENGLISH = [
    8.167, 1.492, 2.782, 4.253, 12.702, 2.228, 2.015, 6.094, 6.966, 0.153, 0.772, 4.025, 2.406,
    6.749, 7.507, 1.929, 0.095, 5.987, 6.327, 9.056, 2.758, 0.978, 2.360, 0.150, 1.974, 0.074,
]
LETTERS = np.array(list("abcdefghijklmnopqrstuvwxyz"))


def written(kind, n, count, rng):
    """Tokens of the model: classes (letters, digits, upper case, separators) that are left with 0.1 a step."""
    if kind == "base64":
        leave, to, start = [0.1, 0.1, 0.1, 1.0], [[0, 0.4, 0.4, 0.2], [0.6, 0, 0.2, 0.2], [0.8, 0.1, 0, 0.1], [0.7, 0.15, 0.15, 0]], [0.7, 0.1, 0.2, 0]
    else:
        leave, to, start = [0.1, 0.1], [[0, 1], [1, 0]], [0.5, 0.5] if kind == "hex" else [0.8, 0.2]
    leave, to = np.array(leave), np.cumsum(to, axis=1)
    at = rng.choice(len(leave), count, p=start)
    share = np.array(ENGLISH) / sum(ENGLISH)
    columns = []
    for j in range(n):
        if j:
            go = rng.random(count) < leave[at]
            at = np.where(go, (rng.random(count)[:, None] > to[at]).sum(1), at)
        word = rng.choice(LETTERS, count, p=share)
        if kind == "hex":
            columns.append(np.where(at == 1, rng.integers(0, 10, count).astype(str), rng.choice(LETTERS[:6], count)))
        elif kind == "base32":
            columns.append(np.where(at == 1, rng.integers(2, 8, count).astype(str), np.char.upper(word)))
        else:
            digit, mark = rng.integers(0, 10, count).astype(str), rng.choice(np.array(list("+/")), count)
            columns.append(np.select([at == 0, at == 1, at == 2], [word, digit, np.char.upper(word)], mark))
    return ["".join(x) for x in np.stack(columns, axis=1)]


def uniform(kind, n, count, rng):
    letters = {"hex": secrets_scan.HEX_SET, "base32": secrets_scan.BASE32_SET, "base64": secrets_scan.BASE64_SET}[kind]
    return ["".join(x) for x in rng.choice(np.array(list(letters)), (count, n))]


def z_values(spark, tokens):
    df = spark.createDataFrame([(t,) for t in tokens], "t string").repartition(4)
    return np.array([r[0] for r in df.select(secrets_scan.battery(F.col("t"))).collect()])


@pytest.mark.parametrize("kind", ["hex", "base32", "base64"])
def test_rates_and_recall_by_length(spark, kind):
    """False discoveries near the stated rate at any length, recall that grows with it."""
    rng = np.random.default_rng(12)
    count, tail = 4000, {0.02: 2.0537, 0.005: 2.5758}
    recall = []
    for n in (20, 27, 40, 80, 200, 700):  # between and beyond the lengths of the table
        z = z_values(spark, written(kind, n, count, rng))
        for rate, level in tail.items():
            spread = 4 * (rate / count) ** 0.5
            assert 0.6 * rate - spread < (z > level).mean() < 1.5 * rate + spread, (n, rate, (z > level).mean())
        recall.append((z_values(spark, uniform(kind, n, 500, rng)) > 3.0902).mean())
    assert recall[0] > 0.5 and recall[2] > 0.93 and min(recall[3:]) > 0.99
    assert all(b > a - 0.03 for a, b in zip(recall, recall[1:]))
