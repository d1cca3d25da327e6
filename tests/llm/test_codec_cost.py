"""What the codec costs: CPU time of encoding and decoding."""

import time

import numpy as np

from corpuslake.llm import codec


def skewed(n):
    rng = np.random.default_rng(7)
    return np.minimum(rng.zipf(1.3, n), 3000)


def test_time_of_an_id():
    """CPU time of an id, in the time that the machine takes for a known sum just then."""
    ids = skewed(1_500_000)
    spins = []
    for _ in range(9):
        t = time.thread_time()
        sum(range(50_000))
        spins.append(time.thread_time() - t)
    t = time.process_time()
    back = codec.decode_ids(codec.encode_ids(ids))
    took = time.process_time() - t
    assert (back == ids).all()
    assert took / len(ids) < 2e-3 * sorted(spins)[4]
