import numpy as np

from postsift.llm import language_id


def test_a_segment_is_read_with_eight_bytes_of_context(monkeypatch):
    """The byte eight places past a segment's end reaches its labels; those further off do not."""
    seen = []
    net = language_id.BiGru(["a", "b"])
    monkeypatch.setattr(net, "probabilities", lambda codes: (seen.append(codes), np.full((*codes.shape, 2), 0.5))[1])
    size = language_id.SEGMENT
    text = "".join(chr(97 + i % 26) for i in range(3 * size))
    language_id.predict(net, [text])
    middle = bytes(seen[0][:, 1].astype(np.uint8)).decode()
    assert middle == text[size - 8 : 2 * size + 8]


def test_labelling_runs_the_trained_states():
    """The forward pass without what training keeps gives its states, saturated gates included, for bytes and padding."""
    rng = np.random.default_rng(2)
    net = language_id.BiGru(["a", "b", "c"], seed=5)
    net.tables[0][:100] *= 400  # far beyond where exp overflows
    codes = rng.integers(0, 257, (40, 33))
    for side in range(2):
        assert np.allclose(net.run(codes, side), net.states(codes, side)[0], atol=1e-6)
    p = net.probabilities(codes)
    assert p.shape == (40, 33, 3) and np.allclose(p.sum(-1), 1, atol=1e-5)
