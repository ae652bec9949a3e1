"""The models of operators 3 and 9 against plain loops, finite differences and sums by hand."""

import math
import re

import numpy as np
import pytest

from gridweave.llm import language_id, toxicity
from gridweave.llm.common import mix, word_hashes


def plain_loss(inputs, state, out, bias, x, y):
    """Mean cross-entropy over the positions that aren't padding, position by position in double precision."""
    h_n = state.shape[1]
    logistic = lambda v: 1 / (1 + np.exp(-v))
    total = count = 0
    for row, label in zip(x, y, strict=True):
        run = []
        for way in (0, 1):
            h, seen = np.zeros(h_n), []
            for byte in row if way == 0 else row[::-1]:
                a, u = inputs[way, byte], h @ state[way]
                z, r = logistic(a[:h_n] + u[:h_n]), logistic(a[h_n : 2 * h_n] + u[h_n : 2 * h_n])
                n = np.tanh(a[2 * h_n :] + r * u[2 * h_n :])
                h = (1 - z) * n + z * h
                seen.append(h)
            run.append(seen if way == 0 else seen[::-1])
        for t, byte in enumerate(row):
            if byte != language_id.PAD:
                v = np.concatenate([run[0][t], run[1][t]]) @ out + bias
                total += np.log(np.exp(v - v.max()).sum()) + v.max() - v[label]
                count += 1
    return total / count


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(11)
    net = language_id.init(["de", "en", "fr"], hidden=5)
    x = rng.integers(97, 103, (4, 9))
    x[1, 6:] = x[3, 1:] = language_id.PAD
    return net, x, np.array([0, 2, 1, 1])


def test_backpropagation_meets_finite_differences(small):
    net, x, y = small
    loss, found = language_id.gradients(net, x, y)
    at = [p.astype(np.float64) for p in (net.inputs, net.state, net.out, net.bias)]
    assert loss == pytest.approx(plain_loss(*at, x, y), rel=1e-5)
    rng = np.random.default_rng(12)
    for k, grad in enumerate(found):
        large = np.argsort(np.abs(grad), axis=None)[-6:]
        some = rng.choice(np.flatnonzero(grad) if k else np.flatnonzero(grad.any(-1, keepdims=True) * np.ones_like(grad)), 6)
        for place in np.concatenate([large, some]):
            sides = []
            for step in (1e-5, -1e-5):
                moved = [p.copy() for p in at]
                moved[k].flat[place] += step
                sides.append(plain_loss(*moved, x, y))
            assert grad.flat[place] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=2e-3, abs=2e-6)
    assert not found[0][:, language_id.PAD].any()


def test_document_probabilities_are_means_over_positions(small):
    net = small[0]
    some = [b"abcdefgh" * 40, b"", b"xyz"]
    offs = np.cumsum([0, *map(len, some)])
    got = language_id.predict(net, np.frombuffer(b"".join(some), np.uint8), offs)
    assert got[1].tolist() == [0, 0, 0]
    for k in (0, 2):
        # the loss of a label at each position of each window gives its probability there
        want, size = np.zeros(3), language_id.WINDOW
        for at in range(0, len(some[k]), size):
            window = np.frombuffer(some[k][at : at + size], np.uint8).astype(np.int64)
            p = language_id.softmax(language_id.logits(net, language_id.states(net, window[None])[0]))
            want += p[:, 0].sum(0)
        assert got[k] / got[k].sum() == pytest.approx(want / want.sum(), rel=1e-4)


def test_ftrl_is_the_plain_loop_over_coordinates():
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        y = k % 3 == 0
        rows.append((np.unique(np.concatenate([rng.integers(0, 200, 12), [7, 9] if y else [11]])), int(y)))
    got = toxicity.Ftrl(bits=8, alpha=0.7, beta=0.9, l1=1.5, l2=0.2).fit(rows, epochs=3, seed=4)

    z, n, bias = [0.0] * 257, [0.0] * 257, 256
    order = np.random.default_rng(4)

    def weight(i):
        l1 = 0 if i == bias else 1.5
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((0.9 + math.sqrt(n[i])) / 0.7 + 0.2)

    for _ in range(3):
        for k in order.permutation(len(rows)):
            at = [*map(int, rows[k][0]), bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - rows[k][1]
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7 * w[i]
                n[i] += g * g
    assert got.z == pytest.approx(z, abs=1e-9) and got.n == pytest.approx(n, abs=1e-9)
    keep, values, b = got.compact()
    assert dict(zip(keep.tolist(), values.tolist(), strict=True)) == pytest.approx({i: weight(i) for i in range(256) if weight(i)}, rel=1e-6)
    assert b == pytest.approx(weight(bias)) and 0 < len(keep) < 200 and 7 in keep


def named(text):
    """The features of a text, from its words, pairs and skip-grams one by one."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text))
    h = [word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]), "letter")[0] for w in words]
    out = {int(mix(v.copy())[0]) for v in h}
    for gap in (1, 2, 3):
        for a, b in zip(h, h[gap:]):  # noqa: B905
            out.add(int(mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ np.uint64(gap)) * np.uint64(0xA0761D6478BD642F))[0]))
    return {v % (1 << toxicity.BITS) for v in out}


def test_scores_by_hand():
    some = [b"You FOOL, you fool! You fool", b"", "schöne grüße — a b c d e".encode(), b"one", b"...", b"you"]
    rng = np.random.default_rng(6)
    dense = rng.standard_normal(1 << toxicity.BITS).astype(np.float32) * (rng.random(1 << toxicity.BITS) < 0.5)
    got = toxicity.score_texts(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]), dense, -0.5)
    want = [1 / (1 + math.exp(-(sum(float(dense[i]) for i in named(t)) - 0.5))) for t in some]
    assert got == pytest.approx(want, rel=1e-5)
    assert got[1] == got[4] == pytest.approx(1 / (1 + math.exp(0.5)))


def test_values_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "12 !?"), (4, "you fool")], "doc_id long, text string")
    model = (np.array([], np.int32), np.array([], np.float32), -1.25)
    scores = {r.doc_id: (r.held_out, round(r.score, 9), r.predicted) for r in toxicity.toxicity_scores(docs, model).collect()}
    bias = round(1 / (1 + math.exp(1.25)), 9)
    assert {v[1:] for v in scores.values()} == {(bias, 0)} and scores[None][0] is False
    assert {r.score for r in toxicity.toxicity_scores(docs, None).collect()} == {0.0}
    for net in (None, language_id.init(["de", "en"], hidden=4)):
        rows = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in language_id.language_ids(docs, net).collect()}
        assert [rows[k][1] for k in (1, 2, None)] == ["und"] * 3 and rows[None][0] is False
        assert rows[4][1] in (("und",) if net is None else ("de", "en")) and 0 <= rows[4][2] <= 1
        assert rows[1][2] == rows[2][2] == rows[None][2] == 0
