"""The models against plain versions: a forward pass step by step, pooling byte by byte, a sum over all pairs of terms."""

import numpy as np
import pytest

from postsift.llm import language_id, support, toxicity


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_states(net, codes, side):
    k, state, out = len(net.recurrent[side]), np.zeros(len(net.recurrent[side])), [None] * len(codes)
    for t in range(len(codes)) if not side else range(len(codes) - 1, -1, -1):
        x, s = net.tables[side][codes[t]].astype(float), state @ net.recurrent[side].astype(float)
        reset, update = sigmoid(x[:k] + s[:k]), sigmoid(x[k : 2 * k] + s[k : 2 * k])
        fresh = np.tanh(x[2 * k :] + reset * s[2 * k :])
        state = (1 - update) * fresh + update * state
        out[t] = state
    return out


def plain_probabilities(net, codes):
    both = zip(plain_states(net, codes, 0), plain_states(net, codes, 1), strict=True)
    logits = [f @ net.out[0] + b @ net.out[1] + net.bias for f, b in both]
    return [np.exp(x) / np.exp(x).sum() for x in logits]


def test_network_and_pooling_step_by_step():
    net = language_id.BiGru(["a", "b", "c"], units=4, seed=3)
    size, margin = language_id.SEGMENT, language_id.MARGIN
    texts = ["short", "été 12", "x" * size, "one two " * 40, "漢字 and more " * 20, "1 2 3", None, ""]
    found = language_id.predict(net, texts, rows_at_once=3)
    for text, got in zip(texts, found, strict=True):
        data = list((text or "").encode())
        sums, n = np.zeros(3), 0
        for at in range(0, len(data), size):
            codes = [data[i] if 0 <= i < len(data) else 256 for i in range(at - margin, at + size + margin)]
            for i, p in list(enumerate(plain_probabilities(net, codes), at - margin))[margin:-margin]:
                if i < len(data) and language_id._LETTER[data[i]]:
                    sums, n = sums + p, n + 1
        if n:
            assert got == pytest.approx(sums / n, abs=1e-4)
        else:
            assert np.isnan(got).all()


def test_machine_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(0)
    slot = np.full(1 << toxicity.BUCKET_BITS, -1, np.int32)
    texts = ["one two three", "three four", "one one one", "", None, "nothing known", "five " * 500 + "two"]
    docs, buckets = toxicity._terms(["one two three four five"])
    slot[np.unique(buckets)] = np.arange(len(np.unique(buckets)))
    n = int(slot.max()) + 1
    machine = toxicity.FactorizationMachine(slot, rng.normal(size=n), rng.normal(size=(n, toxicity.FACTORS)), -0.5)
    for text, got in zip(texts, machine.score(texts), strict=True):
        own = sorted({int(slot[b]) for b in toxicity._terms([text])[1] if slot[b] >= 0})
        want = machine.bias + sum(machine.w[i] for i in own) + sum(machine.v[i] @ machine.v[j] for i in own for j in own if i < j)
        assert got == pytest.approx(sigmoid(want))


def pair_rows(n=6000, seed=1):
    """The insult (1) is toxic in one row of five; beside the group (2), neutral by itself, nearly always."""
    rng = np.random.default_rng(seed)
    terms, labels = [], []
    for _ in range(n):
        insult, group = rng.random() < 0.06, rng.random() < 0.15
        labels.append(int(rng.random() < (0.95 if insult and group else 0.1 if insult else 0.01)))
        terms.append(np.unique(np.array([1] * insult + [2] * group + rng.integers(100, 3000, 30).tolist(), np.int32)))
    return terms, np.array(labels)


def test_a_term_that_counts_only_beside_another_is_learned():
    terms, labels = pair_rows()
    gain, _ = toxicity._gain(np.concatenate(terms), np.repeat(labels, [len(t) for t in terms]) == 1, len(labels), int(labels.sum()))
    machine = toxicity.fit(terms, labels)  # the screens as they are
    assert machine.slot[1] >= 0 and machine.slot[2] >= 0
    value = {own: machine.logits(np.zeros(len(own), int), machine.slot[list(own)].astype(int), 1)[0] if own else machine.bias for own in [(), (1,), (2,), (1, 2)]}
    assert value[1, 2] > 1 > -1 > value[1,] and value[2,] < -2 and value[()] < -2
    noise = sum(machine.slot[100:3000] >= 0)
    assert noise < 30


def test_sample_does_not_depend_on_arrival(spark):
    rows = [(None if i % 3 else i % 500, f"text {i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    first = {tuple(r) for r in support.hash_sample(frame, 300).collect()}
    again = {tuple(r) for r in support.hash_sample(frame.repartition(5), 300).collect()}
    assert first == again and 150 < len(first) <= 600 and {r[0] is None for r in first} == {True, False}
